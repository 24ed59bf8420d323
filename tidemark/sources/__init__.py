"""Where records come from and go to: the block store, generated records, and views of other tables."""
