"""Reading and writing of the tables and topics."""
