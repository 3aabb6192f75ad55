"""Where the given tables are."""

DATA = "/root/testdata"
