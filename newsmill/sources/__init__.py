"""Tables, views and external formats."""
