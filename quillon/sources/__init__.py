"""Tables from files, databases and binary pages."""
