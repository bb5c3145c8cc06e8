"""Report and graph writers: each gives rows (line_no, line)."""
