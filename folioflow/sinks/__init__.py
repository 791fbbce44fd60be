"""Writers: rendered books and reports."""
