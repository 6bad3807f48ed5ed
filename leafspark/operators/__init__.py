"""Relations over corpora of documents: docs(doc_id, content) in, tables out."""
