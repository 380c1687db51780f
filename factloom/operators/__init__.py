"""From inputs to facts and reports."""
