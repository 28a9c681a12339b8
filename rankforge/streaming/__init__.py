"""Nothing here: what this engine matches is batch work over files, without streams, watermarks or state."""
