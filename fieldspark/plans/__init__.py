"""The registered queries, on the tables of the driver."""
