"""Reading, building, checking and writing tables of bars."""
