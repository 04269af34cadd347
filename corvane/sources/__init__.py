from corvane.sources.labelled import literal, parse_label, read_labelled, read_stats, validate_schema
from corvane.sources.store import cache_is_valid, read_cache, read_manifest, read_model, read_vocabulary, write_cache, write_model, write_vocabulary

__all__ = ["cache_is_valid", "literal", "parse_label", "read_cache", "read_labelled", "read_manifest", "read_model", "read_stats", "read_vocabulary", "validate_schema", "write_cache", "write_model", "write_vocabulary"]
