"""PySpark-native analytics for collectible prices, ratings, events and text."""
