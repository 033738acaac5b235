"""Fixed schemas and enumerations of the catalog, volumes, texts and audit log."""

from __future__ import annotations

# The states and kinds that records may have.
VOLUME_STATUS = ("active", "in_progress", "in_review", "reviewed", "duplicate_under_review", "skipped")
MATCHING_STATUS = ("pending", "ready", "active", "in_progress", "in_review", "reviewed")
SEGMENT_TYPE = ("text", "editorial")
DOCUMENT_TYPE = ("volume_etext", "work", "person")
RECORD_STATUS = ("new", "active", "duplicate", "withdrawn", "deleted")
ORIGIN = ("imported", "local")
BOUNDARY = ("clean", "shared_page", "page_snap")
AUDIT_ACTIONS = ("create", "edit", "merge", "delete", "withdraw", "import_create", "import_update")

SEGMENT = "struct<mw_id:string,wa_id:string,cstart:int,cend:int,segment_type:string,title_bo:array<string>,author_name_bo:array<string>,title_orig_bo:array<string>,author_name_orig_bo:array<string>>"
PAGE = "struct<cstart:int,cend:int,pnum:int,pname:string>"
CHUNK = "struct<cstart:int,cend:int,text_bo:string>"

VOLUMES = f"id string, type string, rep_id string, vol_id string, vol_version string, etext_source string, batch_id string, status string, status_matching string, volume_number smallint, wa_id string, mw_id string, nb_pages int, cstart int, cend int, first_imported_at timestamp, last_updated_at timestamp, pages array<{PAGE}>, chunks array<{CHUNK}>, segments array<{SEGMENT}>"
LIFECYCLE = "origin string, record_status string, canonical_id string, db_score float, curation struct<modified:boolean,modified_at:timestamp,modified_by:string,edit_version:int>, source_meta struct<updated_at:timestamp>, import struct<last_run_at:timestamp,last_result:string>"
WORKS = f"id string, pref_label_bo string, alt_label_bo array<string>, authors array<string>, versions array<string>, {LIFECYCLE}"
PERSONS = f"id string, pref_label_bo string, alt_label_bo array<string>, dates string, {LIFECYCLE}"
TEXTS = "mw_id string, volume_id string, vol_id string, vol_version string, rep_id string, root_mw_id string, etext_source string, segment_idx int, title_bo string, wa_id_orig string, cstart int, cend int, cstart_clean int, cend_clean int, boundary_start string, boundary_end string, text_bo string, minhash_lsh array<string>, text_length int, synced_at timestamp"
AUDIT = "timestamp timestamp, actor string, type string, id string, action string, correlation_id string, diff string"
QUADS = "g string, s string, p string, o string, lang string"
OCR_PAGES = "img_file_name string, ok boolean, text string, line_texts array<string>"
GROUND_TRUTH = "mw_id string, d_id string, rkts_id string, nlm_id string"
#: The largest half-precision number; database scores are clamped to it.
MOST_HALF = 65504.0
