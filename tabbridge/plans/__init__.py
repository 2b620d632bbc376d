"""Jobs of several steps: imports, SQL passthrough, batch modes, housekeeping."""
