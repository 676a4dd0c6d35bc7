"""Operators over keyed records: ranges, scans, limits, splitting, versions, keys."""
