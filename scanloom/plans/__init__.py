"""Queries over the driver's tables, laid out as scans, and the SQL that each is held against."""
