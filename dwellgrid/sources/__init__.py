"""Reading raw and prepared data, and writing results."""
