"""Explicit schemas of the tables that operators exchange."""

PAGE = "uri string, status_code int, html string, headers map<string,string>, download_time timestamp"
DOCUMENT = "doc_id bigint, url string, title string, text string, links array<string>, crawl_time timestamp"
CRAWLED = "id string, url string, title string, text string, outgoingLinks array<string>, crawlTime string"
POSTING = "term string, doc_id bigint, tf bigint, positions array<int>"
JUDGED_DOCUMENT = "_id string, title string, text string"
JUDGED_QUERY = "_id string, text string"
QREL = "query_id string, doc_id string, grade int"
VECTOR = "doc_id bigint, vec array<float>"
CLICK = "query string, doc_id bigint, url string, position int, ts timestamp, session_id string"
IMPRESSION = "query string, ts timestamp, docs array<bigint>"
CRAWL_TASK = "url string, domain string, depth int, state string, priority int, next_crawl timestamp, retry_count int"
