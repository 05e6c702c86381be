"""The registered queries, each with its SQL where SQL has one."""
