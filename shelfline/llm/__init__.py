"""Operators that prepare training text: each module holds one operator, `queries` names one query per operator."""
