"""The query catalogue: each reference operator applied to the driver's tables, with its SQL oracle."""
