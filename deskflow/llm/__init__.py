"""Training-data operators (dealt list). Nothing else in the library imports this."""
