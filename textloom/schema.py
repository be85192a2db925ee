"""Declared types of the tables that operators exchange."""

LINK = "struct<l:int,r:int,surface:string,entity:string,etype:string>"
LINKS = f"array<{LINK}>"
TOKEN = "struct<word:string,flag:string,l:int,r:int,is_entity:boolean>"
TOKENS = f"array<{TOKEN}>"
ARC = "struct<id:int,word:string,tag:string,rel:string,head:int>"
ARCS = f"array<{ARC}>"
TRIPLE = "struct<s:string,v:string,o:string>"
EDGES = "u string, v string, weight long"
NEW_WORDS = "text string, freq double, left_ent double, right_ent double, agg double, score double"
DEFAULT_TYPE, NEW_WORD_TYPE = "添加词", "新词"
