"""Inputs of the event, session and anomaly operators, derived from the test tables.

One text serves both engines: ``{name}`` stands for a table or another fixture, ``{text}`` for the string type, ``sha256_hex(x)`` for
the digest and ``json_text(x, path)`` for a JSON field. Everything is deterministic: no clock, no random numbers.
"""

from __future__ import annotations

import re

FIXTURES: dict[str, str] = {
    # raw events as a producer sends them; one kind of damage for each of several primes
    "log_event": """
        SELECT event_id,
          CASE WHEN event_id % 101 = 0 THEN '' ELSE 'evt-' || CAST(event_id AS {text}) END AS log_id,
          CAST(CASE WHEN event_id % 103 = 0 THEN 0 ELSE 1 END AS INT) AS revision,
          CAST(CASE WHEN event_type = 'error' THEN 40 ELSE 20 END AS INT) AS severity,
          CASE WHEN event_id % 107 = 0 THEN '' ELSE event_type END AS event_type,
          CASE WHEN event_id % 109 = 0 THEN '' ELSE 'vision' END AS source_node,
          CASE WHEN event_id % 113 = 0 THEN '' ELSE 'inst-' || CAST(event_id % 3 AS {text}) END AS producer_instance_id,
          'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id,
          CASE WHEN event_id % 127 = 0 THEN CAST(-1 AS BIGINT) ELSE event_id * 1000000 END AS occurred_at_ns,
          payload_json,
          CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE sha256_hex(payload_json) END AS payload_digest
        FROM (SELECT *,
            CASE WHEN event_id % 131 = 0 THEN '{{"k": ' WHEN event_id % 137 = 0 THEN '[1]'
            ELSE '{{"schema_version":' || CASE WHEN event_id % 139 = 0 THEN '3' ELSE '2' END
              || ',"event_type":"' || event_type || '","source_node":"vision","product_id":"'
              || CASE WHEN event_id % 149 = 0 THEN 'other' ELSE 'P-' || lpad(CAST(user_id AS {text}), 6, '0') END
              || '","severity":' || CASE WHEN event_id % 151 = 0 THEN '10' WHEN event_type = 'error' THEN '40' ELSE '20' END
              || ',"payload":' || CASE WHEN event_id % 157 = 0 THEN '[]' ELSE props END || '}}' END AS payload_json
          FROM {events}) e""",
    # stored envelopes of five event types
    "envelope": """
        SELECT event_id, 's' || CAST(user_id % 5 AS {text}) AS session_id, 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id,
          CASE event_type WHEN 'error' THEN 'VISION_STATION_FAILURE_DURABLE' WHEN 'purchase' THEN 'VISION_STATION_RESULT_DURABLE' WHEN 'view' THEN 'VISION_CAPTURE_TIMING'
            WHEN 'click' THEN 'VISION_GPU_METRICS_SNAPSHOT' ELSE 'PRODUCT_RESULT_LOCKED' END AS event_type,
          '{{"schema_version":2,"session_id":"' || CASE WHEN event_id % 83 = 0 THEN '' ELSE 's' || CAST(user_id % 5 AS {text}) END || '","payload":'
          || CASE WHEN event_id % 89 = 0 THEN '[1]' ELSE
            '{{"inference_job_id":"job-' || CAST(event_id % 700 AS {text}) || '"'
            || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"result_revision":' || CAST(event_id % 4 + 1 AS {text}) END
            || ',"fifo_sequence":' || CAST(user_id AS {text}) || ',"station_id":' || CAST(1 + event_id % 2 AS {text})
            || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"verdict":' || CAST(1 + event_id % 3 % 2 AS {text}) END
            || ',"score":' || CAST(CAST(floor(value) AS BIGINT) AS {text}) || '.5'
            || ',"capture_id":"cap-' || CAST(event_id % 900 AS {text}) || '","capture_and_save_ms":' || CAST(CAST(floor(value) AS BIGINT) AS {text})
            || ',"validation_ms":' || CAST(event_id % 7 AS {text}) || ',"capture_timeout_candidate_ms":' || CAST(CAST(floor(value) AS BIGINT) * 2 + event_id % 7 AS {text})
            || ',"gpu_sample_count":' || CAST(event_id % 50 AS {text}) || ',"normal_shutdown":' || CASE WHEN event_id % 11 = 0 THEN 'true' ELSE 'false' END
            || ',"mean_vram_used_mib":' || CAST(event_id % 1000 AS {text}) || ',"image_paths":["/img/' || CAST(user_id AS {text}) || '/' || CAST(event_id % 400 AS {text}) || '.png",""]'
            || ',"reason":"r' || CAST(event_id % 6 AS {text}) || '"}}' END || '}}' AS payload_json
        FROM {events}""",
    "station_terminal": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id, user_id AS fifo_sequence,
          CAST(1 + event_id % 2 AS INT) AS station_id, event_id AS revision, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'RESULT' END AS terminal_kind,
          'job-' || CAST(event_id AS {text}) AS inference_job_id, 'cap-' || CAST(event_id AS {text}) AS capture_id, 'fb-' || CAST(event_id AS {text}) AS frame_batch_id,
          CAST(CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS INT) AS verdict,
          CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS score,
          CAST(CASE WHEN event_type = 'error' THEN 2000 END AS INT) AS error_code,
          CASE WHEN event_type = 'error' THEN '' WHEN user_id % 5 = 3 AND event_id % 4 = 0 THEN 'm2' ELSE 'm1' END AS model_version,
          'sha' AS model_sha256, CASE WHEN user_id % 5 = 4 AND event_id % 2 = 0 THEN 'fp-b' ELSE 'fp' END AS config_fingerprint,
          CASE WHEN event_type = 'error' THEN NULL ELSE value / 4 END AS model_forward_ms,
          CASE WHEN event_type = 'error' THEN NULL ELSE value END AS enqueue_to_result_ms,
          CASE WHEN event_type = 'error' THEN NULL ELSE event_id * 1000000 END AS capture_completed_monotonic_ns,
          CASE WHEN event_type = 'error' THEN NULL ELSE event_id * 1000000 + CAST(floor(value * 1000) AS BIGINT) * 1000 END AS completed_monotonic_ns
        FROM {events}""",
    "product_terminal": """
        SELECT DISTINCT 's' || CAST(user_id % 5 AS {text}) AS session_id, 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id, user_id AS fifo_sequence,
          CASE WHEN user_id % 7 = 0 THEN 'NG' WHEN user_id % 11 = 0 THEN 'FORCED_NG' ELSE 'PASS' END AS final_verdict, 'both station results completed' AS reason
        FROM {events}""",
    "capture_timing": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, 'cap-' || CAST(event_id AS {text}) AS capture_id, CAST(1 + event_id % 2 AS INT) AS station_id,
          value AS acquisition_ms, value / 2 AS save_ms, value / 10 AS validation_ms FROM {events} WHERE event_type = 'view'""",
    "gpu_sample": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, event_id AS sampled_at, least(value, 100) AS util, value * 10 AS vram, CAST(8192 + event_id % 3 AS BIGINT) AS total_vram
        FROM {events} WHERE event_type = 'click'""",
    "gpu_snapshot": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, event_id AS arrival, CAST(event_id % 50 AS BIGINT) AS sample_count, event_id % 11 = 0 AS normal_shutdown,
          CAST(event_id % 1000 AS DOUBLE) AS mean_vram_used_mib FROM {events} WHERE event_type = 'click'""",
    "image_artifact": """
        SELECT event_id AS artifact_order, 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id,
          CASE WHEN event_id % 61 = 0 THEN '/tmp/' ELSE '/data/img/' END || CAST(user_id AS {text}) || '/' || CAST(event_id AS {text}) || '.png' AS file_path FROM {events}""",
    "spool": """
        SELECT 'evt-' || CAST(event_id AS {text}) AS log_id, CAST(1 + event_id % 2 AS INT) AS revision, props AS payload_json, sha256_hex(props) AS payload_digest,
          event_id - event_id % 10 AS created_at FROM {events}""",
    "ack": """
        SELECT CASE WHEN event_id % 41 = 0 THEN ' ' ELSE 'evt-' || CAST(event_id AS {text}) END AS log_id, CAST(CASE WHEN event_id % 43 = 0 THEN 0 ELSE 1 + event_id % 2 END AS INT) AS revision,
          CAST(floor(event_id / 64) AS BIGINT) AS batch FROM {events} WHERE event_id % 3 <> 0""",
    # what arrives for stored keys: new, repeated, or changed
    "incoming": """
        SELECT 'evt-' || CAST(event_id AS {text}) AS log_id, CAST(1 + event_id % 2 AS INT) AS revision,
          CASE WHEN event_id % 17 = 0 THEN sha256_hex('changed') ELSE sha256_hex(props) END AS payload_digest FROM {events} WHERE event_id % 4 <> 1""",
    "stored": """
        SELECT log_id, revision, payload_digest FROM {spool} WHERE CAST(substr(log_id, 5) AS BIGINT) % 2 = 0""",
    # events in the order of arrival, some sent again later, some of those with another text
    "arrival_event": """
        SELECT arrival, log_id, revision, severity, event_type, source_node, producer_instance_id, product_id, occurred_at_ns, payload_json, payload_digest FROM (
          SELECT event_id * 2 AS arrival, log_id, revision, severity, event_type, source_node, producer_instance_id, product_id, occurred_at_ns, payload_json, payload_digest FROM {log_event}
          UNION ALL
          SELECT arrival, log_id, revision, severity, event_type, source_node, producer_instance_id, product_id, occurred_at_ns, payload_json, sha256_hex(payload_json) AS payload_digest FROM (
            SELECT event_id * 2 + 777 AS arrival, log_id, revision, severity, event_type, source_node, producer_instance_id, product_id, occurred_at_ns,
              CASE WHEN event_id % 5 = 0 THEN payload_json || ' ' ELSE payload_json END AS payload_json FROM {log_event} WHERE event_id % 9 = 4) again) a""",
    "sensor_event": """
        SELECT sensor_id, event_id, sequence, digest, arrival FROM (
          SELECT 'S' || CAST(user_id % 3 + 1 AS {text}) AS sensor_id, 'ev-' || CAST(event_id AS {text}) AS event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS sequence,
            'd' || CAST(event_id AS {text}) AS digest, event_id * 2 AS arrival, event_id AS n FROM {events}) a WHERE n % 500 <> 7
        UNION ALL
        SELECT sensor_id, event_id, sequence, CASE WHEN n % 800 = 3 THEN 'other' ELSE digest END AS digest, arrival + 1 AS arrival FROM (
          SELECT 'S' || CAST(user_id % 3 + 1 AS {text}) AS sensor_id, 'ev-' || CAST(event_id AS {text}) AS event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS sequence,
            'd' || CAST(event_id AS {text}) AS digest, event_id * 2 AS arrival, event_id AS n FROM {events}) b WHERE n % 400 = 3""",
    "heartbeat": """
        SELECT CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'vision' ELSE 'log' END AS node_id, 'i' || CAST(CAST(floor(event_id / 1000) AS BIGINT) AS {text}) AS instance_id,
          CASE WHEN event_id % 37 = 0 THEN event_id - 5 ELSE event_id END AS sequence, event_id AS arrival, CAST(event_id % 19 AS INT) AS health,
          CASE WHEN event_id % 997 = 0 THEN '2.0.0' ELSE '2.1.0' END AS interface_version, event_id * 1000000 AS received_ns FROM {events}""",
    "ledger": """
        SELECT product_id, fifo_sequence, CAST(1 + fifo_sequence % 9 AS INT) AS physical_state, fifo_sequence % 13 = 0 AS removed, fifo_sequence % 10 = 0 AS locked, fifo_sequence % 9 = 8 OR fifo_sequence < 20 AS completed
        FROM {product_terminal} WHERE fifo_sequence % 17 <> 0""",
    "capture_owner": """
        SELECT 'cap-' || CAST(event_id AS {text}) AS capture_id, 'P-' || lpad(CAST(CASE WHEN event_id % 29 = 0 THEN user_id + 1 ELSE user_id END AS {text}), 6, '0') AS owner_product,
          CAST(1 + event_id % 2 AS INT) AS owner_station FROM {events} WHERE event_id % 31 <> 0""",
    "active_capture": """
        SELECT product_id, station_id, max(capture_id) AS active_capture_id FROM {station_terminal} WHERE revision % 31 <> 0 AND revision % 29 <> 0 GROUP BY product_id, station_id""",
    "retired_product": """
        SELECT product_id, fifo_sequence FROM {product_terminal} WHERE fifo_sequence % 34 = 0""",
    "removal": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id, min(event_id) * 1000 + user_id % 7 AS removed_ms FROM {events} WHERE user_id % 4 <> 1 GROUP BY user_id""",
    "product_message": """
        SELECT event_id AS message_id, 's' || CAST(user_id % 5 AS {text}) AS session_id, 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id, event_id * 1000 AS at_ms FROM {events}""",
    "station_message": """
        SELECT event_id AS message_id, 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id, user_id AS fifo_sequence, CAST(CASE WHEN event_id % 211 = 0 THEN 7 ELSE 1 + event_id % 2 END AS INT) AS station_id_raw,
          'cap-' || CAST(CASE WHEN event_id % 5 = 0 THEN event_id ELSE event_id - event_id % 5 END AS {text}) AS capture_id_near, 'cap-' || CAST(event_id AS {text}) AS capture_id,
          CASE WHEN event_id % 227 = 0 THEN '' ELSE 'fb' END AS frame_batch_id, CASE WHEN event_id % 229 = 0 THEN '' ELSE 'job' END AS inference_job_id,
          CAST(CASE WHEN event_id % 233 = 0 THEN 0 ELSE 1 END AS INT) AS result_revision, CAST(CASE WHEN event_id % 239 = 0 THEN 9 ELSE 1 + event_id % 2 END AS INT) AS verdict_raw,
          CASE WHEN event_id % 223 = 0 THEN NULL ELSE value END AS score, event_type <> 'error' AS expects_verdict FROM {events}""",
    # products with what their stations reported before the lock
    "station_facts": """
        SELECT user_id AS fifo_sequence, 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id, user_id % 23 = 0 AS a_failed, user_id % 31 = 0 AS b_failed, user_id % 37 = 0 AS a_conflicted, user_id % 41 = 0 AS b_conflicted,
          CAST(CASE WHEN user_id % 6 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 2 ELSE 1 END AS INT) AS a_verdict, CAST(CASE WHEN user_id % 8 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS INT) AS b_verdict
        FROM (SELECT DISTINCT user_id FROM {events}) u""",
    "lock_arrival": """
        SELECT user_id AS fifo_sequence, max(event_id) AS arrival FROM {events} WHERE user_id % 19 <> 5 GROUP BY user_id""",
    "system_event": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, event_id AS arrival,
          CASE CAST(event_id * 7 % 22 AS INT) WHEN 0 THEN 'APP_STARTED' WHEN 1 THEN 'INIT_DONE' WHEN 2 THEN 'INIT_FAILED' WHEN 3 THEN 'INIT_TIMEOUT' WHEN 4 THEN 'START_REQUEST' WHEN 5 THEN 'START_FAILED'
            WHEN 6 THEN 'ALL_CONVEYORS_RUNNING' WHEN 7 THEN 'PAUSE_REQUEST' WHEN 8 THEN 'RECOVERABLE_DEVICE_FAULT' WHEN 9 THEN 'ALL_CONVEYORS_STOPPED' WHEN 10 THEN 'PAUSE_FAILED' WHEN 11 THEN 'PAUSE_TIMEOUT'
            WHEN 12 THEN 'RESUME_REQUEST' WHEN 13 THEN 'DEVICE_RECOVERED' WHEN 14 THEN 'RESUME_FAILED' WHEN 15 THEN 'CRITICAL_FAULT' WHEN 16 THEN 'RESET_REQUEST' WHEN 17 THEN 'RESET_SUCCEEDED_EMPTY_LINE'
            WHEN 18 THEN 'RESET_SUCCEEDED_IN_PLACE' WHEN 19 THEN 'RESET_FAILED' WHEN 20 THEN 'RESET_TIMEOUT' ELSE 'ESTOP_ASSERTED' END AS event
        FROM {events}""",
    # calls of the system machine's entry points, in the order in which a line meets them, with what their guards say
    "system_call": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, event_id AS arrival, event_id % 7 <> 0 AS guard,
          CASE CAST(event_id % 31 AS INT) WHEN 0 THEN 'initialize' WHEN 1 THEN 'initialization_done' WHEN 2 THEN 'run' WHEN 3 THEN 'running' WHEN 4 THEN 'pause' WHEN 5 THEN 'stopped' WHEN 6 THEN 'resume' WHEN 7 THEN 'running' WHEN 8 THEN 'pause_automatic'
            WHEN 9 THEN 'stopped' WHEN 10 THEN 'resume_automatic' WHEN 11 THEN 'running' WHEN 12 THEN 'pause_failed' WHEN 13 THEN 'reset' WHEN 14 THEN 'reset_in_place' WHEN 15 THEN 'resume' WHEN 16 THEN 'running' WHEN 17 THEN 'pause_manual' WHEN 18 THEN 'pause_storage'
            WHEN 19 THEN 'run_failed' WHEN 20 THEN 'fault_line' WHEN 21 THEN 'reset' WHEN 22 THEN 'reset_cleared' WHEN 23 THEN 'run' WHEN 24 THEN 'estop' WHEN 25 THEN 'fault_equipment' WHEN 26 THEN 'reset_failed' WHEN 27 THEN 'initialization_failed'
            WHEN 28 THEN 'pause_timeout' WHEN 29 THEN 'reset_timeout' ELSE 'initialization_timeout' END AS call FROM {events}""",
    "inference_job": """
        SELECT event_id AS job_id, user_id AS fifo_sequence, CAST(1 + event_id % 2 AS INT) AS station_id, event_id * 1000000 AS enqueued_ns, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(500 + event_id % 2500 AS BIGINT) END AS timeout_ms,
          CASE WHEN event_id % 6 = 0 THEN 'CUDA out of memory at layer' WHEN event_id % 6 = 1 THEN 'bad shape' ELSE '' END AS failure_text FROM {events}""",
    "command": """
        SELECT event_id AS command_no, CASE WHEN event_id % 13 = 0 THEN 'not-a-uuid' ELSE lower(substr(sha256_hex(props), 1, 8) || '-' || substr(sha256_hex(props), 9, 4) || '-' || CASE WHEN event_id % 7 = 0 THEN '1' ELSE '4' END
            || substr(sha256_hex(props), 14, 3) || '-a' || substr(sha256_hex(props), 18, 3) || '-' || substr(sha256_hex(props), 21, 12)) END AS command_id,
          CASE WHEN event_id % 17 = 0 THEN 'XYZ' ELSE sha256_hex(props) END AS payload_digest, CAST(CASE WHEN event_id % 23 = 0 THEN 5 ELSE 1 END AS INT) AS health_state,
          CASE WHEN event_id % 29 = 0 THEN 'other' ELSE 'live' END AS session_id, event_id % 31 AS command_epoch, CAST(event_id % 8 AS INT) AS system_state, user_id AS operator_no FROM {events}""",
    "equipment": """
        SELECT event_id AS check_no, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE event_id % 8 END AS INT) AS system_state, event_id % 4 <> 1 AS workers_ready, event_id % 5 <> 2 AS mapping_confirmed, CAST(event_id % 2 + 2 AS INT) AS cameras_a, CAST(1 AS INT) AS cameras_b,
          event_id % 6 <> 1 AS spool_available, CAST(event_id % 3 AS INT) AS active_products, event_id % 7 <> 3 AS line_clear, event_id % 8 <> 5 AS conveyors_stopped, event_id % 9 <> 4 AS sensors_clear, event_id % 10 <> 6 AS actuator_safe,
          event_id % 11 = 7 AS estop, CASE event_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'vision' ELSE 'log' END AS worker_id, event_id % 2 = 0 AS restarted FROM {events}""",
    "dataset_file": """
        SELECT vec_id, CASE v WHEN 0 THEN 'CAM_A_1' WHEN 1 THEN 'CAM_A_2' WHEN 2 THEN 'CAM_A_3' ELSE 'CAM_B_1' END AS view, CASE vec_id % 5 WHEN 0 THEN 'calibration_set_A' WHEN 1 THEN 'calibration_set_B' WHEN 2 THEN 'validation_normal' WHEN 3 THEN 'validation_anomaly' ELSE 'test' END AS split,
          'p' || CAST(vec_id AS {text}) || CASE WHEN vec_id % 77 = 0 THEN '.PNG' WHEN vec_id % 79 = 0 THEN '.txt' ELSE '.png' END AS filename
        FROM {embeddings} e, (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) w WHERE NOT (vec_id % 101 = 0 AND v = 2)""",
    # image folders: some names differ in their case alone, some folders hold other files only
    "image_file": """
        SELECT split, view, filename FROM {dataset_file} UNION ALL SELECT split, view, 'P' || substr(filename, 2) AS filename FROM {dataset_file} WHERE vec_id % 97 = 3 AND view <> 'CAM_B_1'
        UNION ALL SELECT 'notes' AS split, view, 'n' || CAST(vec_id AS {text}) || '.txt' AS filename FROM {dataset_file} WHERE vec_id % 50 = 0""",
    "raw_score": """
        SELECT event_id, value AS raw, CASE WHEN event_id % 31 = 0 THEN 0.0 WHEN event_id % 37 = 0 THEN value ELSE 20.0 + user_id % 40 END AS threshold, CAST(event_id % 11 AS DOUBLE) / 100 AS margin FROM {events}""",
    # images of capture results: three cameras at station 1, one at station 2
    "capture_image": """
        SELECT event_id AS capture_no, CAST(2 - (event_id + 1) % 2 AS INT) AS station_id, k AS image_no, 'CAM' || CAST(CASE WHEN event_id % 2 = 1 THEN 3 WHEN event_id % 46 = 0 AND k = 2 THEN 1 WHEN event_id % 58 = 0 AND k = 2 THEN 3 ELSE k END AS {text}) AS camera_id,
          CASE WHEN event_id % 53 = 0 THEN '' ELSE 'b' || CAST(event_id AS {text}) END AS frame_batch_id, CAST(CASE WHEN event_id % 61 = 0 THEN 0 ELSE 1 END AS INT) AS attempt_count, CASE WHEN event_id % 47 = 0 AND k = 0 THEN 'zz' ELSE sha256_hex(props) END AS sha256,
          CASE WHEN event_id % 59 = 0 THEN 0 ELSE 1000 END AS file_size, CASE WHEN event_id % 67 = 0 THEN 'RGB8' ELSE 'MONO8_PNG' END AS pixel_format, event_id * 1000 AS requested_ns, event_id * 1000 + CASE WHEN event_id % 71 = 0 THEN -5 ELSE 80 END AS returned_ns,
          CAST(CASE WHEN event_id % 79 = 0 AND k = 0 THEN 2 ELSE 0 END AS INT) AS lost_packets, CASE WHEN event_id % 43 = 0 THEN '' ELSE 'job' || CAST(event_id AS {text}) END AS inference_job_id, CASE WHEN event_id % 97 = 0 THEN 0 ELSE 2048 END AS width, CASE WHEN event_id % 101 = 0 AND k = 0 THEN -1 ELSE 1536 END AS height,
          CASE WHEN event_id % 103 = 0 THEN 0 ELSE 1700000000000000000 + event_id END AS requested_wall_ns, 1700000000000000000 + event_id - CASE WHEN event_id % 107 = 0 THEN 3 ELSE -3 END AS returned_wall_ns, CASE WHEN event_id % 83 = 0 THEN 'img/' ELSE '/data/' END || CAST(event_id AS {text}) || '.png' AS file_path
        FROM {events} e, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) w WHERE (event_id % 2 = 0 OR k = 0) AND NOT (event_id % 62 = 0 AND k = 1)""",
    "model_view": """
        SELECT event_id AS job_id, CAST(2 - (event_id + 1) % 2 AS INT) AS station_id, k AS view_no, CAST(CASE WHEN event_id % 73 = 0 THEN 7 WHEN (event_id + k) % 5 = 0 THEN 2 ELSE 1 END AS INT) AS view_verdict,
          CASE WHEN event_id % 89 = 0 AND k = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS view_score, CASE WHEN event_id % 83 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 97 = 0 THEN NULL ELSE value END AS score,
          CAST(CASE WHEN event_id % 101 = 0 THEN 2 WHEN event_id % 2 = 0 THEN 3 ELSE 1 END AS INT) AS image_paths, CAST(CASE WHEN event_id % 37 = 0 THEN 2 WHEN event_id % 5 = 0 OR event_id % 2 = 0 AND event_id % 5 IN (3, 4) THEN 2 ELSE 1 END AS INT) AS verdict
        FROM {events} e, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) w WHERE (event_id % 2 = 0 OR k = 0) AND NOT (event_id % 62 = 0 AND k = 1)""",
    "master_beat": """
        SELECT 'n' || CAST(user_id % 7 AS {text}) AS node_id, event_id AS arrival, CASE WHEN event_id % 31 = 0 THEN '1.0' ELSE '2.0' END AS interface_version, CASE WHEN event_id % 29 = 0 THEN 'old' ELSE 'live' END AS session_id,
          CAST(floor(event_id / 100) AS BIGINT) - CASE WHEN event_id % 17 = 0 THEN 3 ELSE 0 END AS command_epoch, CAST(event_id % 12 AS INT) AS system_state FROM {events}""",
    "actuation": """
        SELECT event_id AS arrival, 'act-' || CAST(event_id % 700 AS {text}) AS actuation_id, 'P-' || CAST(CASE WHEN event_id % 13 = 0 THEN user_id ELSE event_id % 700 END AS {text}) AS product_id, CASE WHEN event_id % 3 = 0 THEN 'NG' WHEN event_id % 3 = 1 THEN 'FORCED_NG' ELSE 'PASS' END AS verdict FROM {events}""",
    # messages of stations and locks; identities, verdicts and revisions that disagree now and then
    "ledger_message": """
        SELECT 'P-' || lpad(CAST(user_id AS {text}), 6, '0') AS product_id, CAST(1 + event_id % 2 AS INT) AS station_id, event_id * 2 AS arrival,
          CASE WHEN event_id % 389 = 0 AND user_id % 2 = 1 THEN 'CONTRACT' WHEN event_type = 'error' AND user_id % 5 = 1 THEN 'FAILURE' ELSE 'RESULT' END AS kind,
          CAST(floor(event_id / 60) AS BIGINT) + 1 - CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS revision,
          CAST(CASE WHEN user_id % 6 = 0 THEN 2 WHEN user_id % 3 = 0 AND event_id % 11 = 0 THEN 2 WHEN user_id % 7 = 0 AND event_id % 13 = 0 THEN 2 ELSE 1 END AS INT) AS verdict,
          'cap-' || CAST(CASE WHEN event_id % 31 = 0 THEN 0 ELSE user_id END AS {text}) AS capture_id, 'cap-' || CAST(user_id AS {text}) AS expected_capture,
          'fb-' || CAST(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS {text}) AS frame_batch_id, 'job-' || CAST(CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END AS {text}) AS inference_job_id
        FROM {events}
        UNION ALL
        SELECT 'P-' || lpad(CAST(fifo_sequence AS {text}), 6, '0') AS product_id, CAST(0 AS INT) AS station_id, arrival * 2 - 600 + k * (300 + fifo_sequence % 5) + 1 AS arrival, 'LOCK' AS kind, CAST(0 AS BIGINT) AS revision,
          CAST(NULL AS INT) AS verdict, '' AS capture_id, '' AS expected_capture, '' AS frame_batch_id, 's3-' || CAST(CASE WHEN fifo_sequence % 4 = 3 THEN k ELSE 0 END AS {text}) AS inference_job_id
        FROM {lock_arrival} l, (SELECT 0 AS k UNION ALL SELECT 1) w""",
    "registration": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, event_id AS arrival, CASE WHEN event_id % 43 = 0 THEN '' ELSE 'P-' || CAST(CASE WHEN event_id % 7 = 0 THEN event_id - 7 ELSE event_id END AS {text}) END AS product_id,
          CASE WHEN event_id % 47 = 0 THEN 0 WHEN event_id % 53 = 0 THEN event_id - 60 ELSE event_id END AS fifo_sequence FROM {events}""",
    "cycle_event": """
        SELECT product_id, station_id, arrival, CASE CAST(n % 11 AS INT) WHEN 1 THEN 'BEGIN' WHEN 2 THEN 'SETTLED' WHEN 3 THEN 'SETTLED' WHEN 4 THEN 'REQUESTED' WHEN 5 THEN 'RESET' WHEN 6 THEN 'BEGIN' WHEN 7 THEN 'SETTLED' WHEN 8 THEN 'REQUESTED' WHEN 9 THEN 'REQUESTED' WHEN 10 THEN 'SUCCEEDED' ELSE 'FAILED' END AS event,
          'pos-' || CASE WHEN arrival % 29 = 0 THEN 'x' ELSE '1' END AS position_command, 'cap-' || CASE WHEN arrival % 31 = 0 THEN 'x' ELSE '1' END AS capture_id, 'cmd-' || CASE WHEN arrival % 5 = 0 THEN 'x' ELSE '1' END AS capture_command
        FROM (SELECT user_id AS product_id, CAST(1 + event_id % 2 AS INT) AS station_id, event_id AS arrival, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS n FROM {events}) x""",
    "actuation_event": """
        SELECT product_id, arrival, CASE CAST(n % 5 AS INT) WHEN 1 THEN 'BEGIN' WHEN 2 THEN 'BEGIN' WHEN 3 THEN 'ACCEPTED' ELSE 'COMPLETED' END AS event, 'aj-1' AS actuator_job,
          'cmd-' || CASE WHEN arrival % 7 = 0 THEN 'x' ELSE '1' END AS command, 'act-' || CAST(arrival AS {text}) AS actuation_id
        FROM (SELECT user_id AS product_id, event_id AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}) x""",
    "operator_command": """
        SELECT event_id AS arrival, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'no-uuid' ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS request_id,
          CAST(k % 8 AS INT) AS command_type, CASE WHEN event_id % 17 = 0 THEN 'again' ELSE 'shift' END AS reason, CASE WHEN k % 3 = 0 THEN '' ELSE 'op1' END AS operator_id
        FROM (SELECT event_id, k, sha256_hex(k_text) AS h FROM (SELECT event_id, event_id % 601 AS k, CAST(event_id % 601 AS {text}) AS k_text FROM {events}) y) x""",
    "capture_goal": """
        SELECT event_id AS goal_no, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'P-1' END AS product_id, CASE WHEN event_id % 23 = 0 THEN '' ELSE 'cap-' || CAST(event_id AS {text}) END AS capture_id, CAST(event_id % 4 AS INT) AS station_id,
          CASE WHEN event_id % 29 = 0 THEN 'CAM1,CAM0,CAM2' WHEN event_id % 4 = 2 THEN 'CAM3' ELSE 'CAM0,CAM1,CAM2' END AS camera_list, CASE WHEN event_id % 31 = 0 THEN '' ELSE 'c' END AS command_id, event_id % 37 = 0 AS cancelled, event_id % 41 = 0 AS shutdown FROM {events}""",
    "worker_state": """
        SELECT event_id AS check_no, event_id % 13 <> 1 AS action_ready, event_id % 17 <> 1 AS status_verified, event_id % 47 <> 2 AS status_ready, event_id % 53 <> 2 AS master_alive, 'i1' AS status_instance, CASE WHEN event_id % 19 = 0 THEN 'i2' ELSE 'i1' END AS beat_instance, CASE WHEN event_id % 23 = 0 THEN '' ELSE 'live' END AS status_session,
          CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'live' END AS beat_session, CASE WHEN event_id % 31 = 0 THEN '1.0' ELSE '2.0' END AS interface_version, CAST(7 - CAST(floor(event_id % 37 / 36) AS BIGINT) AS BIGINT) AS command_epoch, event_id AS status_sequence,
          event_id + 2 - event_id % 7 % 4 AS beat_sequence, CAST(1 + CAST(floor(event_id % 41 / 40) AS INT) AS INT) AS status_health, CAST(1 + CAST(floor(event_id % 43 / 42) AS INT) AS INT) AS beat_health, event_id * 1000 AS received_ns, event_id * 1000 + event_id % 110 AS now_ns FROM {events}""",
    # messages of workers that start, with a status of the present command epoch, but for some that lag
    "worker_message": """
        SELECT worker, arrival, at_ms, kind, code, instance, number, CAST(1 + sum(CASE WHEN kind = 'EPOCH' THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY arrival) - CASE WHEN arrival % 23 = 0 THEN 1 ELSE 0 END AS BIGINT) AS epoch FROM (
          SELECT 'w' || CAST(user_id % 13 AS {text}) || CASE WHEN event_id % 2 = 0 THEN '/control' ELSE '/vision' END AS worker, event_id AS arrival, 1000 + event_id * 20 AS at_ms,
            CASE CAST(draw AS INT) WHEN 0 THEN 'START' WHEN 1 THEN 'GOAL' WHEN 2 THEN 'RESULT' WHEN 3 THEN 'STATUS' WHEN 4 THEN 'BEAT' WHEN 5 THEN 'GOAL' WHEN 6 THEN 'RESULT' WHEN 7 THEN 'STATUS' WHEN 8 THEN 'BEAT' WHEN 9 THEN 'STATUS' WHEN 10 THEN 'EPOCH' ELSE 'BEAT' END AS kind,
            CAST(CASE CAST(draw AS INT) WHEN 1 THEN CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END WHEN 5 THEN 0 WHEN 2 THEN CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 13 = 0 THEN 2 ELSE 0 END WHEN 3 THEN CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 17 = 0 THEN 2 ELSE 0 END
              WHEN 4 THEN CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END ELSE 0 END AS INT) AS code,
            CASE WHEN event_id % 53 = 0 THEN 'i2' ELSE 'i1' END AS instance, CASE WHEN event_id % 41 = 0 THEN CAST(0 AS BIGINT) WHEN draw IN (3, 7, 9) THEN event_id - 150 ELSE event_id END AS number
          FROM (SELECT *, event_id * 5 % 13 AS draw FROM {events}) e) m""",
    "serial_command": """
        SELECT event_id AS sequence, event_id * 10 AS sent_ms FROM {events} WHERE event_id % 9 <> 4""",
    "serial_answer": """
        SELECT event_id AS sequence, event_id * 10 + event_id * 7 % 130 - 5 + k * 3 AS received_ms, CASE WHEN event_id % 8 = 0 AND k = 0 THEN 'ERR_LIMIT' ELSE 'OK' END AS status FROM {events} e, (SELECT 0 AS k UNION ALL SELECT 1) w WHERE event_id % 6 <> 5""",
    "option_text": """
        SELECT event_id AS option_no, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '{{"method":"epsilon","epsilon_ratio":' || v || '}}' WHEN 1 THEN '{{"method":"std_floor","std_floor_ratio":' || v || CASE WHEN event_id % 11 = 0 THEN ',"extra":1}}' ELSE '}}' END
            WHEN 2 THEN '{{"method":"shrinkage","shrinkage_lambda":' || v || '}}' WHEN 3 THEN '{{"method":"mad","mad_epsilon_ratio":' || v || '}}' ELSE '{{"method":"none"}}' END AS normalization,
          CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '{{"method":"percentile","percentile":' || p || '}}' WHEN 1 THEN '{{"method":"top_k_percent_average","top_k_percent":' || p || ',"rounding":"' || CASE WHEN event_id % 13 = 0 THEN 'floor' ELSE 'ceil' END || '","minimum_patch_count":' || CASE WHEN event_id % 17 = 0 THEN '2' ELSE '1' END || '}}' ELSE '{{"method":"mean"}}' END AS aggregation,
          '{{"v_threshold":' || CASE WHEN event_id % 19 = 0 THEN '300' WHEN event_id % 23 = 0 THEN '"9"' ELSE '9' END || ',"connectivity":' || CASE WHEN event_id % 29 = 0 THEN '4' ELSE '8' END || ',"remove_disconnected_noise":' || CASE WHEN event_id % 31 = 0 THEN 'false' ELSE 'true' END || CASE WHEN event_id % 37 = 0 THEN '}}' ELSE ',"check_connection":false}}' END AS preprocessing
        FROM (SELECT event_id, CASE CAST(event_id * 7 % 9 AS INT) WHEN 0 THEN '0.05' WHEN 1 THEN '0.1' WHEN 2 THEN '0.2' WHEN 3 THEN '0' WHEN 4 THEN '-1' WHEN 5 THEN '0.001' WHEN 6 THEN '0.5' WHEN 7 THEN '"x"' ELSE '2' END AS v, CASE CAST(event_id * 5 % 7 AS INT) WHEN 0 THEN '95.0' WHEN 1 THEN '99.25' WHEN 2 THEN '2.0' WHEN 3 THEN '10.0' WHEN 4 THEN '50' WHEN 5 THEN '100.0' ELSE '0.5' END AS p FROM {events}) x""",
    "tuning_text": """
        SELECT event_id AS document_no, CASE WHEN event_id % 37 = 0 THEN '[1]' WHEN event_id % 41 = 0 THEN '{{"schema' ELSE '{{"model_version":"' || CASE WHEN event_id % 11 = 0 THEN 'm2' ELSE 'm1' END || '","model_sha256":"sha","config_fingerprint":"fp","schema_version":' || CASE WHEN event_id % 13 = 0 THEN '2' ELSE '1' END
            || ',"minimum_samples":' || CAST(20 + event_id % 100 AS {text}) || ',"safety_factor":' || CASE WHEN event_id % 17 = 0 THEN '2.0' ELSE '1.5' END || ',"timeouts_ms":{{"station_a":' || CAST(event_id % 5 * 100 AS {text}) || CASE WHEN event_id % 19 = 0 THEN '}}' WHEN event_id % 3 = 0 THEN ',"station_b":null}}' ELSE ',"station_b":900}}' END || '}}' END AS document
        FROM {events}""",
    "spatial_patch": """
        SELECT CAST(floor(event_id / 16) AS BIGINT) AS payload_no, event_id % 16 AS patch, CASE WHEN event_id % 227 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS center, CASE WHEN event_id % 211 = 0 THEN 0.0 ELSE 0.5 END AS denominator, CASE WHEN event_id % 223 = 0 THEN -1.0 ELSE 0.25 END AS raw_scale,
          CASE WHEN CAST(floor(event_id / 16) AS BIGINT) % 17 = 0 THEN 0.0 ELSE 1.5 END AS scale_reference, CAST(CASE WHEN CAST(floor(event_id / 16) AS BIGINT) % 13 = 0 THEN 1 ELSE 40 END AS INT) AS sample_count FROM {events} WHERE event_id % 229 <> 0""",
    "queue_message": """
        SELECT 's' || CAST(user_id % 5 AS {text}) AS session_id, event_id AS arrival, CASE CAST(event_id * 7 % 5 AS INT) WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'ACCEPTING' WHEN 2 THEN 'STOPPED' WHEN 3 THEN 'BLOCKED' ELSE 'ACCEPTING' END AS kind, event_id % 3 = 0 AS paused, event_id % 23 = 0 AS frozen FROM {events}""",
    # manifests of artifacts, each kind of damage for one prime
    "manifest": """
        SELECT event_id AS manifest_no, CASE WHEN event_id % 127 = 0 THEN '[' || t || ']' WHEN event_id % 131 = 0 THEN substr(t, 2) ELSE replace(t, 'DIGEST', CASE WHEN event_id % 137 = 0 THEN 'XYZ' ELSE h END) END AS text FROM (
          SELECT event_id, h, replace(replace(replace(replace(replace(t, CASE WHEN event_id % 101 = 0 THEN '"actual":3' ELSE '#' END, '"actual":4'), CASE WHEN event_id % 103 = 0 THEN '"selected_parallel_count":2' ELSE '#' END, '"selected_parallel_count":4'), CASE WHEN event_id % 107 = 0 THEN '"memory_safe":true' ELSE '#' END, '"memory_safe":false'), CASE WHEN event_id % 109 = 0 THEN '"thresholds":{{"CAM_A_1":1.5,"CAM_A_2":1.5,"CAM_A_3":1.5,"CAM_B_1":1.5}},"threshold_p' ELSE '#' END, '"thresholds":{{"CAM_A_1":1.5,"CAM_A_2":1.5,"CAM_A_3":1.5,"CAM_B_1":2.5}},"threshold_p'), CASE WHEN event_id % 113 = 0 THEN '"artifact_name":"m1"' ELSE '#' END, '"artifact_name":7') AS t FROM (SELECT event_id, h, replace(replace(replace(replace(replace(t, CASE WHEN event_id % 73 = 0 THEN '"candidate_id":"c6"' ELSE '#' END, '"candidate_id":"c7"'), CASE WHEN event_id % 79 = 0 THEN '"status":"valid"' ELSE '#' END, '"status":"stale"'), CASE WHEN event_id % 83 = 0 THEN '"fpr":0.08' ELSE '#' END, '"fpr":0.3'), CASE WHEN event_id % 89 = 0 THEN '"file_count":100' ELSE '#' END, '"file_count":99'), CASE WHEN event_id % 97 = 0 THEN '"torch":"2.1",' ELSE '#' END, '') AS t FROM (SELECT event_id, h, replace(replace(replace(replace(replace(t, CASE WHEN event_id % 53 = 0 THEN '"epsilon_ratio":0.1}}' ELSE '#' END, '"epsilon_ratio":7}}'), CASE WHEN event_id % 59 = 0 THEN '"target_product_fpr":0.1' ELSE '#' END, '"target_product_fpr":0.2'), CASE WHEN event_id % 61 = 0 THEN '"CAM_B_1":1.5}},"patch' ELSE '#' END, '"CAM_B_1":-1.5}},"patch'), CASE WHEN event_id % 67 = 0 THEN '"CAM_A_2":[0.5,0.25,1.0]' ELSE '#' END, '"CAM_A_2":[0.5,null,1.0]'), CASE WHEN event_id % 71 = 0 THEN '"CAM_A_1":[4,4]' ELSE '#' END, '"CAM_A_1":[4,0]') AS t FROM (SELECT event_id, h, replace(replace(replace(replace(replace(t, CASE WHEN event_id % 31 = 0 THEN '"format_version":3' ELSE '#' END, '"format_version":2'), CASE WHEN event_id % 37 = 0 THEN '"algorithm":"patchcore"' ELSE '#' END, '"algorithm":"other"'), CASE WHEN event_id % 41 = 0 THEN '"CAM_A_3","CAM_B_1"]' ELSE '#' END, '"CAM_B_1","CAM_A_3"]'), CASE WHEN event_id % 43 = 0 THEN '"thresholds":{{"CAM_A_1":1.5,' ELSE '#' END, '"thresholds":{{"CAM_X":1.5,'), CASE WHEN event_id % 47 = 0 THEN '"decision":{{' ELSE '#' END, '"choice":{{') AS t FROM (SELECT event_id, sha256_hex(props) AS h, '{{"format_version":3,"algorithm":"patchcore","artifact_name":"m1","view_names":["CAM_A_1","CAM_A_2","CAM_A_3","CAM_B_1"],"thresholds":{{"CAM_A_1":1.5,"CAM_A_2":1.5,"CAM_A_3":1.5,"CAM_B_1":1.5}},"patch_grid_shapes":{{"CAM_A_1":[4,4],"CAM_A_2":[4,4],"CAM_A_3":[4,4],"CAM_B_1":[4,4]}},"memory_bank_shapes":{{"CAM_A_1":[48,16],"CAM_A_2":[48,16],"CAM_A_3":[48,16],"CAM_B_1":[48,16]}},"calibration_b_scores":{{"CAM_A_1":[0.5,0.25,1.0],"CAM_A_2":[0.5,0.25,1.0],"CAM_A_3":[0.5,0.25,1.0],"CAM_B_1":[0.5,0.25,1.0]}},"spatial_scoring_policy":{{"normalization":{{"method":"epsilon","epsilon_ratio":0.1}},"aggregation":{{"method":"percentile","percentile":99.5}},"decision":{{"comparison":"strict_greater_than","view_score_normalization":"divide_by_threshold","target_product_fpr":0.1,"threshold_percentile":97.5}}}},"candidate_selection":{{"selected_candidate_id":"c7","candidates":[{{"candidate_id":"c6","status":"failed"}},{{"candidate_id":"c7","status":"valid","eligible_for_selection":true,"thresholds":{{"CAM_A_1":1.5,"CAM_A_2":1.5,"CAM_A_3":1.5,"CAM_B_1":1.5}},"threshold_percentile":97.5,"calibration_product_fpr":0.05,"validation_metrics":{{"fpr":0.08}}}}]}},"dataset_provenance":{{"calibration_a":{{"product_count":25,"file_count":100,"sha256":"DIGEST"}},"calibration_b":{{"product_count":25,"file_count":100,"sha256":"DIGEST"}},"validation_normal":{{"product_count":25,"file_count":100,"sha256":"DIGEST"}},"validation_anomaly":{{"product_count":25,"file_count":100,"sha256":"DIGEST"}}}},"library_versions":{{"torch":"2.1","torchvision":"0.16"}},"calibration_b_sample_policy":{{"minimum":100,"recommended":1000,"actual":3}},"parallel_benchmark":{{"selected_parallel_count":2,"reserve_mib":512,"warmup_runs":3,"benchmark_runs":20,"min_speedup_percent":5.0,"candidates":[1,2,3],"all_view_memory_safety":{{"memory_safe":true}}}}}}' AS t FROM {events}) d0) d5) d10) d15) m""",
    "version_pair": """
        SELECT event_id AS entry_no, '2.' || CAST(user_id % 4 AS {text}) || '.0' || CASE WHEN event_id % 3 = 0 THEN '+cu12' ELSE '' END AS required,
          '2.' || CAST(CASE WHEN event_id % 5 = 0 THEN event_id ELSE user_id END % 4 AS {text}) || '.0' || CASE WHEN event_id % 2 = 0 THEN '+cu12' WHEN event_id % 7 = 0 THEN '+cpu' ELSE '' END AS installed FROM {events}""",
    "model_entry": """
        SELECT event_id AS entry_no, CASE WHEN event_id % 11 = 0 THEN 'models/' ELSE '/models/' END || CAST(event_id % 9 AS {text}) AS path, CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN NULL ELSE 'm1' END AS version,
          CASE WHEN event_id % 19 = 0 THEN 'zz' WHEN event_id % 3 = 0 THEN upper(sha256_hex(props)) ELSE sha256_hex(props) END AS expected, CASE WHEN event_id % 23 = 0 THEN sha256_hex('other') ELSE sha256_hex(props) END AS actual, event_id % 4 AS worker_count, event_id % 2 = 0 AS serialize_access FROM {events}""",
    # inference jobs with the times at which they are looked at, and the attempts to read their images
    "job_run": """
        SELECT event_id AS job_id, enqueued_ns, timeout_ms, dequeued_ns, dequeued_ns + event_id % 23 * 1000000 AS loaded_ns, dequeued_ns + (event_id % 23 + event_id % 31) * 1000000 AS completed_ns,
          CASE WHEN event_id % 3 = 0 THEN enqueued_ns + event_id * 7 % 110 * 1000000 END AS cancelled_ns,
          CASE CAST(event_id % 29 AS INT) WHEN 0 THEN 'CUDA out of memory at layer' WHEN 1 THEN 'bad shape' WHEN 2 THEN 'deadline' ELSE '' END AS forward_error
        FROM (SELECT event_id, event_id * 1000000 AS enqueued_ns, (event_id + event_id % 50) * 1000000 AS dequeued_ns, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 40 + event_id % 60 END AS timeout_ms FROM {events}) e""",
    "job_image": """
        SELECT event_id AS job_id, k AS image_no, CASE WHEN (event_id * 3 + k) % 37 = 0 THEN 'preprocessing' WHEN (event_id * 5 + k) % 11 = 0 THEN 'io' ELSE '' END AS first_error,
          CASE WHEN event_id % 13 = 0 THEN 'preprocessing' WHEN event_id % 2 = 0 THEN 'io' ELSE '' END AS second_error, (event_id + event_id % 50) * 1000000 + event_id % 23 * 500000 AS retried_ns
        FROM {events} e, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) w""",
    "phase_timer": """
        SELECT event_id AS timer_no, CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'CAPTURE_GOAL' WHEN 1 THEN 'WAITING_CAPTURE_RESULT' WHEN 2 THEN 'WAITING_POSITION' WHEN 3 THEN 'RESUME_PENDING' WHEN 4 THEN 'WAITING_RESULT' WHEN 5 THEN 'GOAL_PENDING' ELSE 'POSITIONED' END AS phase,
          CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id * 1000 END AS deadline_ns, event_id * 1000 + event_id % 5 - 2 AS now_ns, event_id % 3 = 0 AS queue_paused, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 2 = 0 END AS conveyor_running FROM {events}""",
    "actuation_goal": """
        SELECT event_id AS arrival, 'cmd-' || CAST(event_id % 601 AS {text}) AS command_id, CASE WHEN event_id % 17 = 0 THEN 'other' ELSE 'same' END AS payload_digest, event_id % 19 <> 0 AS header_valid,
          CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'ERR_LIMIT' ELSE 'OK' END AS answer FROM {events}""",
    "discard_event": """
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'VISION_INFERENCE_CANCELED' ELSE 'VISION_CAPTURE_DISCARDED' END AS event_type,
          '{{"image_paths":[' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '"/img/' || CAST(event_id AS {text}) || '/0.png"' || CASE WHEN event_id % 2 = 0 THEN ',"","/img/2.png"' ELSE '' END END || ']}}' AS payload_json FROM {events}""",
    "old_file": """
        SELECT CASE CAST(vec_id % 4 AS INT) WHEN 0 THEN 'training_set' WHEN 1 THEN 'val_set' WHEN 2 THEN 'test_set_normal' ELSE 'test_set_anomaly' END AS split, 'V' || CAST(v AS {text}) AS view, 'p' || CAST(vec_id AS {text}) || '.png' AS filename
        FROM {embeddings} e, (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) w WHERE NOT (vec_id % 23 = 0 AND v = 2) AND NOT (vec_id % 29 = 0 AND v = 0)""",
    "library_set": """
        SELECT event_id AS set_no, CASE WHEN event_id % 7 = 0 THEN '2.6.1' WHEN event_id % 11 = 0 THEN NULL ELSE '2.6.0' END AS anomalib, CASE WHEN event_id % 5 = 0 THEN '2.12.1' ELSE '2.12.1+cu132' END AS torch, CASE WHEN event_id % 3 = 0 THEN '2.6.50' ELSE '2.6.5' END AS lightning FROM {events}""",
    "station_context": """
        SELECT 'P-' || CAST(event_id AS {text}) AS product_id, event_id AS fifo_sequence, CASE WHEN event_id % 2 = 0 THEN 'STATION_A_DONE' ELSE 'SENSOR3_WAIT' END AS physical_state, event_id % 9 AS revision, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'NG' ELSE 'PASS' END AS verdict,
          station, 'cap-' || station || CAST(event_id AS {text}) AS capture_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'PASS' END AS result, CASE WHEN event_id % 7 = 0 AND station = 'A' THEN 'model' ELSE '' END AS failure_reason, CASE WHEN event_id % 11 = 0 AND station = 'B' THEN 'after A' WHEN event_id % 13 = 0 THEN NULL ELSE '' END AS skip_reason
        FROM {events} e, (SELECT 'A' AS station UNION ALL SELECT 'B') w""",
    "sensor_pass": """
        SELECT event_id AS arrival, user_id AS product_id, CAST(event_id % 3 + 1 AS INT) AS sensor_index, 'e' || CAST(user_id AS {text}) || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END AS sensor_event FROM {events}""",
    "prediction": """
        SELECT doc_id, CAST(toxic AS INT) AS truth, CAST(1 - quality AS INT) AS predicted FROM {labels} WHERE toxic IS NOT NULL AND quality IS NOT NULL""",
    "disk_sample": """
        SELECT event_id AS sample_no, 's' || CAST(user_id % 5 AS {text}) AS session_id, (event_id * 13 % 100) / 100.0 AS used_ratio FROM {events}""",
    "camera_entry": """
        SELECT CAST(floor(event_id / 4) AS BIGINT) AS inventory, 'SN' || CAST(CASE WHEN event_id % 47 = 0 THEN 9 ELSE event_id % 4 END AS {text}) AS serial, CASE WHEN event_id % 53 = 0 THEN 'MV-X' ELSE 'MV-1' END AS model,
          CASE WHEN event_id % 59 = 0 THEN 'fw2' ELSE 'fw1' END AS firmware FROM {events}""",
    "serial_line": """
        SELECT event_id, 'E|SENSOR|' || CAST(user_id % 3 + 1 AS {text}) || '|' || CAST(event_id AS {text}) AS body FROM {events}""",
    "distance_sample": """
        SELECT event_id AS sample_no, CAST(user_id % 3 + 1 AS INT) AS sensor_id, CASE WHEN event_id % 67 = 0 THEN NULL ELSE CAST(event_id * 37 % 200 AS DOUBLE) / 10 END AS distance_cm, event_id % 5 <> 0 AS conveyor_running FROM {events}""",
}


def needs(text: str) -> list[str]:
    """Names of the tables and fixtures that a text reads."""
    return [n for n in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)) if n != "text"]


def spark_text(text: str) -> str:
    text = text.replace("{text}", "string")
    text = re.sub(r"sha256_hex\(([^()]*)\)", r"sha2(\1, 256)", text)
    return re.sub(r"json_text\(", "get_json_object(", text)


def _duck(text: str) -> str:
    text = text.replace("{{", "\x01").replace("}}", "\x02").replace("{text}", "varchar")
    text = re.sub(r"\{(\w+)\}", r"\1", text)
    text = re.sub(r"sha256_hex\(([^()]*)\)", r"sha256(\1)", text)
    return re.sub(r"json_text\(", "json_extract_string(", text).replace("\x01", "{").replace("\x02", "}")


def duck_with(text: str) -> str:
    """``text`` after the definitions of all fixtures that it names."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in FIXTURES and name not in order:
            for n in needs(FIXTURES[name]):
                visit(n)
            order.append(name)

    for name in FIXTURES:
        if re.search(rf"\b{name}\b", text):
            visit(name)
    parts = [f"{n} AS ({_duck(FIXTURES[n])})" for n in order]
    body = text.strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\b", body, re.I))
    if re.match(r"WITH\b", body, re.I):
        parts.append(re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I))
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
