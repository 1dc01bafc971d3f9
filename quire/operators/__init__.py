"""Operators on relations of documents, pages, regions, tables and archives.

Documents are told apart by doc_id, pages are numbered from 0 in page0. All operators
partition by document; none moves the content of a page unless it returns it.
"""
