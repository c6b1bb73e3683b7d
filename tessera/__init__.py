"""tessera: training-data and rollout analytics as Spark DataFrame operators.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``; nothing
is collected to the driver.  Sub-packages:

* ``sources``   -- scans (JSONL / parquet / media files) and sinks
* ``functions`` -- column helpers (keyed randomness, Python-compatible string ops,
                   special-token ids, byte-level token ids)
* ``operators`` -- chat shaping, tokenizer jobs, sequence building, rewards,
                   advantages, ordering, augmentation
* ``plans``     -- composed jobs (SFT samples, RL scoring) and derived fixture tables
* ``streaming`` -- keyed stateful stream operators (speech segments, text deltas, chunking)
"""

__version__ = "0.1.0"
