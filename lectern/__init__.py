"""lectern: text preparation, captions, timelines and paced reading as Spark jobs."""
