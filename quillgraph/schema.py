"""Schemas of the domain tables. Everything may be null but ids."""

from __future__ import annotations

PATENTS = """patent_id string, title string, abstract string, applicant string, applicant_raw string, filing_date string,
filing_year int, application_number string, search_keyword string, title_en string, patent_number string, publication_number string,
publication_date string, applicants array<string>, inventors array<string>, ipc5 array<string>, ipc5_raw array<string>, ipc_primary string,
ipc_depth int, references array<string>, external_references array<string>, cited_by_count int, case_status string, design_class string,
source_files array<string>, search_keywords array<string>, applicant_key string"""

RELATION = "struct<source:string,target:string,relation:string,weight:double,reason:string,confidence:string>"
EXTRACTIONS = f"patent_id string, translated_abstract string, keywords array<string>, relations array<{RELATION}>"
SYNONYM_GROUPS = "id string, canonical string, aliases array<string>, note string"
CITATIONS = "from_patent string, to_patent string"
EVIDENCE = "array<struct<patent_id:string,weight:double,reason:string,confidence:string>>"

NODES = "id string, type string, label string, color string, size double, frequency long, patent_count long, source_patents array<string>, community_id int, community_id_applicants int, year int, applicant_count long, title string, abstract string, source_files array<string>, ipc5 array<string>, first_year int, last_year int, median_year double"
EDGES = f"id string, kind string, `from` string, `to` string, relation string, weight double, support_count long, jaccard double, support_applicants long, jaccard_applicants double, npmi double, npmi_applicants double, association_strength double, association_strength_applicants double, source_patents array<string>, evidence {EVIDENCE}"
