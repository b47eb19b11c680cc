"""Schemas of the raw files and of the activity fields: fixed values, set by the public file format."""

from __future__ import annotations

RAW_ITEMS = "movie_id STRING, title STRING, genres STRING"
RAW_USERS = "user_id STRING, gender STRING, age INT, occupation INT, zipcode STRING"
RAW_EVENTS = "user_id STRING, movie_id STRING, rating INT, timestamp INT"

# One interaction, in the order by which a history is sorted.
ACTIVITY = ("datetime", "event_name", "event_value", "label", "item_id", "item_text")
FLAGS = ("is_train", "is_val", "is_test", "is_predict")
