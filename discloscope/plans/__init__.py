"""Every operator as a named query over the driver tables, with its SQL check."""
