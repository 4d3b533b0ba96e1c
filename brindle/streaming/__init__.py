"""Nothing: the relational surface has no streaming operator. Tables of events are read as tables."""
