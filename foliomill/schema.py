"""Schemas of the engine's tables."""

ERROR = "struct<kind:string,page:int,retries:int,secs:bigint,detail:string>"
PAGE_RESULT = f"page_num int, markdown string, input_tokens bigint, output_tokens bigint, duration_ms bigint, retries int, error {ERROR}"
#: Beside the result, what rendering took and when work on the page began and ended (milliseconds since 1970).
TIMES = "render_ms bigint, started_ms bigint, ended_ms bigint"
RAW_PAGE = f"doc_id bigint, {PAGE_RESULT}, {TIMES}"
ENCODED_PAGE = "doc_id bigint, page_index int, image_b64 string, mime_type string, detail string, render_encode_ms bigint, started_ms bigint"
METADATA = "doc_id bigint, title string, author string, subject string, creator string, producer string, creation_date string, modification_date string, page_count int, pdf_version string, is_encrypted boolean"
