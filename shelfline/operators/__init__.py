"""Row-set operators that several plans share."""
