"""Training-data operators over the text, vector and link records of slide decks."""
