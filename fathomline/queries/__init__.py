"""The registered queries by subject, each with the SQL that gives the same rows where there is one."""
