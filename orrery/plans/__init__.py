"""Queries over the tables of a scale-factor folder, with the SQL that checks them."""
