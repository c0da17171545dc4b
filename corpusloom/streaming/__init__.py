"""corpusloom.streaming."""
