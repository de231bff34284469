"""The three batch stages and the reports."""
