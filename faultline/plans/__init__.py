"""Fixed points, facades and the registered queries."""
