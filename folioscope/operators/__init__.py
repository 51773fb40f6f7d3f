"""DataFrame operators over documents, pages, blocks, lines, cells and candidates."""
