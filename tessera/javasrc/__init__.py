"""Java source to tables: a tolerant parser, one Arrow stage around it, and name resolution as joins."""
