"""Plan builders and the registered queries."""
