"""slotframe: a PySpark engine for slot-addressed record logs and reference-counted page graphs."""
