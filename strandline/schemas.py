"""Schemas of landed files, given explicitly at read time (nothing is inferred)."""

RAW_ITEM = "title string, url string, publisher string, published_at string, text string"

RSS_ITEM = "title string, link string, pubDate string, published string, updated string, description string, summary string, content string"
ATOM_ENTRY = ("title string, id string, published string, updated string, summary string, description string, content string, "
              "link array<struct<_href:string,_rel:string,_VALUE:string>>")
PAPER_ENTRY = "title string, id string, published string, summary string"

VULN_RESPONSE = ("vulnerabilities array<struct<cve:struct<id:string,published:string,"
                 "descriptions:array<struct<lang:string,value:string>>>>>")
CURATED_ROW = "Title string, URL string, Summary string, Content string, Published string"
DISCOVERY = "url string, title string, found_at timestamp_ntz, label string"
RUN_LOG = ("run_id string, logged_at timestamp_ntz, status string, source_count bigint, rejected_count bigint, "
           "discarded_count bigint, error_message string")
