"""Job plans and the plumbing that long plans share."""
