"""Analyses of binary-outcome markets: functions from Tables to one DataFrame each."""
