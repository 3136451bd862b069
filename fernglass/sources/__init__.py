"""Markdown folders, frontmatter, blocks, chunks and stored vectors."""
