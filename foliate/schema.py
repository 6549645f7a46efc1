"""Record types. A box is a struct of integers, origin at the top left."""

from __future__ import annotations

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"

PAGE_TYPES = ("scanned", "native", "mixed")

#: Names of region types; a detector's class id is the place in this list. Fixed values.
BLOCK_TYPES = ("title", "text", "image", "table", "formula", "header", "footer", "page_number", "caption", "list", "code", "reference")

#: Types that a recognition model reads, and those that assembly leaves out.
RECOGNIZED = ("title", "text", "caption", "list", "reference", "code", "table", "formula")
MARGINAL = ("header", "footer", "page_number")

PAGES = "doc_id long, page_number int, text string, width double, height double, spans array<struct<text:string,font:string,size:double,flags:int,x1:double,x2:double>>, image_ratio double"
LAYOUT_BLOCKS = f"doc_id long, page_number int, pos int, block_type string, bbox {BOX}, confidence double, reading_order int, column_id int"
PROCESSED_BLOCKS = (
    f"doc_id long, page_number int, pos int, block_type string, bbox {BOX}, reading_order int, content string, content_type string,"
    " image_path string, confidence double, source string, validation_passed boolean, validation_warning string"
)
CACHE_ENTRIES = "tier string, key string, ts double, data string"
TASK_EVENTS = "event_id long, task_id long, ts timestamp, kind string"
