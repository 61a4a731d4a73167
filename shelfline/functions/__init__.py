"""Column functions: dates, ids, money and text."""
