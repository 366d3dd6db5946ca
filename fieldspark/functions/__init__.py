"""Libraries of column expressions: wind, moist air, radar, splines."""
