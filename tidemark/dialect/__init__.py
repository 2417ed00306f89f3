"""The text front end: tokens and grammar."""
