"""Mining operators over entries and transactions."""
