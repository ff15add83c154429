"""Small tables the analyses start from; every one can be replaced by the caller's."""
