"""From a specification string to a fitted search plan."""
