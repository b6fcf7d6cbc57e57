"""Tables, scans, transactions and maintenance."""
