"""The same operators on live streams."""
