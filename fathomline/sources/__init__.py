"""Reading and writing pages, edges, indexes and builds."""
