"""Operators: functions from DataFrame to DataFrame, plus eager ``fit_*`` functions with small results."""
