"""The tables of the store as Spark schemas."""

DOCUMENTS = "doc_id string, path string, rel_path string, file_name string, format string, stage string, size_bytes long, mtime double, content_sha string, n_chunks int, status string, error string"
CHUNKS = "chunk_id string, doc_id string, ord int, text string, headings array<string>, page_no int, n_chars int"
VECTORS = "chunk_id string, text_hash string, embedding array<float>"
CACHE = "model_id string, hash string, dim int, vec array<float>"
LISTING = "root_ord int, root string, path string, rel_path string, size_bytes long, mtime double"
