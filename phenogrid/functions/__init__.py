"""Column builders: calendar, geography, names and model-side scalars."""
