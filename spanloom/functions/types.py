"""The Spark types of spans and results, and the enumerations as strings."""

from __future__ import annotations

LEVELS = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
GROUPS = ("PRIVILEGE", "PHI", "MNPI", "PII", "CONFIDENTIAL", "SAFE")
LAYERS = ("REGEX", "NER", "RULES", "LLM")
ROUTES = ("LOCAL_ONLY", "REDACT_CLOUD", "CLOUD_OK")

#: A span as it comes from a scan.
SPAN = "struct<start:int,end:int,category:string,confidence:double,ord:int,layer:string>"
SPANS = f"array<{SPAN}>"
#: A rule's match; confidence has the boost of its context.
HIT = "struct<ord:int,start:int,end:int,rule:string,category:string,group:string,confidence:double,context:boolean,boost_only:boolean>"
HITS = f"array<{HIT}>"
ENTITY = "struct<text:string,category:string,category_group:string,confidence:double,detection_layer:string,start:int,end:int,metadata:map<string,string>>"
ENTITIES = f"array<{ENTITY}>"
MAPPING = "struct<tokens:map<string,string>,categories_redacted:array<string>,profile_id:string,text_hash:string,created_at:string>"
