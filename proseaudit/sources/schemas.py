"""Explicit schemas of the input documents and of the tables we write. Nothing is inferred."""

from __future__ import annotations

NORMALIZED_ELEMENT = (
    "struct<text:string,"
    "locator:struct<page_or_slide_index:int,element_type:string,element_index:int,sub_index:int,position:string>,"
    "formatting:struct<font_name:string,font_size:double,is_bold:boolean,is_italic:boolean,color:string,hierarchy_level:int>,"
    "confidence:double,source_type:string>"
)
SLIDE_ELEMENT = (
    "struct<text:string,"
    "locator:struct<slide_index:int,element_type:string,element_index:int,paragraph_index:int,bullet_level:int>,"
    "formatting:struct<font_name:string,font_size:double,is_bold:boolean,is_italic:boolean,font_color:string>>"
)
PAGE_ELEMENT = (
    "struct<text:string,confidence:double,"
    "locator:struct<page_index:int,paragraph_index:int,element_type:string,position:string>>"
)
CELL = "struct<row_index:int,col_index:int,text:string,is_header:boolean,rowspan:int,colspan:int>"
SLIDE_TABLE = (
    f"struct<slide_index:int,table_index:int,rows:int,columns:int,has_header_row:boolean,cells:array<{CELL}>>"
)
METADATA = (
    "struct<doc_id:string,file_path:string,title:string,author:string,creator:string,creation_date:string,total_pages:int>"
)

NORMALIZED_DOCUMENT = (
    f"document_type string, metadata {METADATA}, "
    f"pages array<struct<index:int,title:string,notes:string,layout_info:string,element_count:int,"
    f"elements:array<{NORMALIZED_ELEMENT}>>>, "
    "extraction_info struct<total_pages:int,total_slides:int,total_elements:int>, normalized_at string, "
    "summary struct<total_pages:int,pages_with_content:int,total_elements:int>, _corrupt_record string"
)
SLIDE_DOCUMENT = (
    "document_type string, metadata struct<file_path:string,title:string,author:string,total_slides:int,"
    "layouts:array<string>,theme:struct<theme_name:string,color_scheme:map<string,string>,font_scheme:map<string,string>>>, "
    f"slides array<struct<slide_index:int,title:string,content_elements:array<{SLIDE_ELEMENT}>,"
    f"tables:array<{SLIDE_TABLE}>,notes:string,layout_name:string,master_name:string,background_color:string>>, "
    "_corrupt_record string"
)
PAGE_DOCUMENT = (
    f"document_type string, metadata {METADATA}, "
    f"pages array<struct<page_index:int,raw_text:string,page_size:string,element_count:int,"
    f"elements:array<{PAGE_ELEMENT}>>>, _corrupt_record string"
)
PROTECTION = (
    "protected_names array<string>, technical_terms array<string>, dates array<string>, "
    "numbers array<string>, abbreviations array<string>, ids array<string>"
)
FORMAT = "struct<font_name:string,font_size:double,is_bold:boolean,is_italic:boolean,color:string,hierarchy_level:int>"

ELEMENTS = (
    "doc_id string, page_index int, ord int, element_index int, element_type string, sub_index int, "
    f"position string, text string, confidence double, source_type string, fmt {FORMAT}"
)
PROGRESS_EVENT = "timestamp timestamp, file_id string, stage string, message string, progress int"
LOG_EVENT = "timestamp timestamp, level string, message string, component string"

USAGE_RESPONSE = "struct<issues:array<struct<line:int,reason:string>>>"
