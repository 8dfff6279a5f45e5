"""What the engine reads and writes: Markdown files, page texts, index folders."""
