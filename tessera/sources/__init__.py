from tessera.sources.tables import TABLES, read_table, with_file_order, with_row_index  # noqa: F401
from tessera.sources.jsonl import (  # noqa: F401
    scan_agent_jsonl,
    scan_preference_jsonl,
    scan_pretrain_jsonl,
    scan_rlaif_jsonl,
    scan_sft_jsonl,
    scan_tokenizer_corpus,
)
from tessera.sources.parquet import (  # noqa: F401
    conversations_from_turns,
    scan_media_dir,
    scan_speech_parquet,
    scan_vision_parquet,
    union_shards,
)
from tessera.sources.sinks import write_training_table  # noqa: F401
