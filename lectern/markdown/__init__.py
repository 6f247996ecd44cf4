"""A document-local Markdown kernel: blocks, plain text of inlines, sections and passages."""
