"""Tables of the data model, and of results that media tools, models and services hand over."""

from __future__ import annotations

SHOTS = "pos bigint, shot_id string, video_path string, existing_speaker string, start_sec double, end_sec double, target_face_box array<int>"
SHOT_RANGES = "pos bigint, shot_id string, start_frame bigint, end_frame bigint, start_sec double, end_sec double, start_tc string, end_tc string, label string"
WORDS = "pos bigint, text string, start double, end double, speaker string, source_group string, transcription_source string, diarized_turn_speaker string, review_required boolean"
LINES = "line_id string, start_sec double, end_sec double, cut_start_sec double, cut_end_sec double, text string, diarized_speaker string, source_group string, speaker string, transcription_source string, review_required boolean"
CLIPS = "pos bigint, path string, clip_id string, clip_type string, line_id string, shot_id string, source_group string, source_stem string, start_sec double, end_sec double, clip_start_sec double, clip_end_sec double, text string, embedding array<double>, kept string"
CLIP_PLAN = "clip_id string, clip_type string, line_id string, shot_id string, speaker string, stem_path string, source_stem string, source_group string, start_sec double, end_sec double, score double, margin double, cluster_id bigint, status string, resolution_source string, text string"
SCENES = "scene_id string, start_sec double, end_sec double, shot_ids array<string>, boundary_score double"
CLUSTERS = "cluster_id bigint, name string, speaker_key string, centroid array<double>, evidence_count bigint"
REGISTRY = "pos bigint, speaker_key string, name string, aliases array<string>, voice_clusters array<bigint>, face_clusters array<bigint>"

#: Handed over by probes: one row a file, one row a stream.
MEDIA_PROBE = "path string, duration_sec double, start_sec double, width int, height int, codec string, r_frame_rate string, avg_frame_rate string, nb_frames bigint, timecode string"
AUDIO_STREAMS = "path string, index int, channels int, layout string, sample_rate int, codec string, language string"
#: Handed over by detectors and recognisers.
CUT_FRAMES = "path string, frame bigint, score double, detector string"
FACE_DETECTIONS = "path string, frame bigint, box array<int>, confidence double, embedding array<float>"
SHOT_EMBEDDINGS = "shot_id string, model string, vec array<float>"
ASR_WORDS = "path string, pos bigint, text string, start double, end double, score double, language string"
LANGUAGE_WINDOWS = "path string, pos bigint, start_sec double, code string, confidence double, voiced_ratio double"
#: Handed over by separation services and taggers.
SEPARATED_STEMS = "source_path string, role string, speaker_number int, path string, task_id string"
EVENT_TAGS = "path string, start_sec double, end_sec double, label string, score double"
#: The analysis bundle.
ARTIFACTS = "artifact_id string, role string, path string, sha256 string, sample_rate int, channels int, frames bigint"
FEATURES = "artifact_id string, name string, kind string, unit string, value variant, start_sec double, hop_sec double, frame_sec double, count bigint"
SERIES = "artifact_id string, name string, i bigint, t_sec double, value double"
MATRIX = "artifact_id string, name string, i bigint, vec array<float>"
ANALYZERS = "artifact_id string, analyzer string, version string, status string, error string, cache_key string"

#: The tables by name, as `sources.captured` reads them.
TABLES = {name.lower(): ddl for name, ddl in list(globals().items()) if name.isupper() and isinstance(ddl, str)}
