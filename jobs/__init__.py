"""Jobs that can be run by themselves: each a function that takes a session, a command line and a config file."""
