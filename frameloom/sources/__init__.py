"""Raw-frame source and sink, probe metadata and folder listings."""
