"""Default tables of the engine.  Every operator takes them as parameters."""
