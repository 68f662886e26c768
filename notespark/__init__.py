"""notespark: document structuring and selection as Spark jobs."""
