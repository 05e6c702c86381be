"""Jobs with a command line and a config file each; their work is a function that takes a session."""
