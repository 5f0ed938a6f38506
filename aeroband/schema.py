"""Declared table schemas.  Jobs never infer types; JSON columns are text read with ``from_json``."""

from __future__ import annotations

from pyspark.sql import types as T

# Table → columns as name:type.
DECLARED = {
    "detections": "id:string timestamp:timestamp drone_type:string confidence:double threat_level:string frequency:double signal_strength:double latitude:double longitude:double altitude:double remote_id:string metadata:string created_at:timestamp updated_at:timestamp is_active:boolean",
    "detection_events": "id:string detection_id:string event_type:string event_data:string timestamp:timestamp",
    "alerts": "id:string detection_id:string severity:string title:string message:string acknowledged:boolean acknowledged_by:string resolved:boolean timestamp:timestamp resolved_at:timestamp escalation_level:int",
    "system_metrics": "id:long timestamp:timestamp metric_name:string metric_value:double metadata:string",
    "drone_signatures": "id:string drone_type:string manufacturer:string signature_data:string frequency_bands:string modulation_types:string bandwidth:double hop_pattern:string confidence:double verified:boolean source:string created_at:timestamp updated_at:timestamp",
    "spectrum_signatures": "id:string name:string signature_type:string spectrum_data:string peak_frequencies:string characteristics:string created_at:timestamp",
    "remote_id_messages": "id:string uas_id:string latitude:double longitude:double altitude:double speed:double heading:double horizontal_accuracy:double vertical_accuracy:double timestamp:timestamp rssi:int frequency:double raw_data:binary status:string operator_id:string operator_latitude:double operator_longitude:double operator_altitude:double created_at:timestamp",
    "remote_id_sessions": "id:string uas_id:string start_time:timestamp end_time:timestamp first_latitude:double first_longitude:double last_latitude:double last_longitude:double max_speed:double avg_altitude:double max_altitude:double track_length:double operator_id:string",
    "remote_id_tracks": "id:string session_id:string timestamp:timestamp latitude:double longitude:double altitude:double speed:double heading:double",
    "alert_escalations": "id:string alert_id:string escalation_level:int triggered_at:timestamp action_taken:string notified_users:string response_received:boolean response_by:string response_at:timestamp",
    "notifications": "id:string alert_id:string channel:string recipient:string subject:string message:string status:string sent_at:timestamp delivered_at:timestamp error:string retry_count:int created_at:timestamp",
    "alert_rules": "id:string name:string description:string severity:string condition:string action:string cooldown_seconds:int escalation_seconds:string enabled:boolean created_at:timestamp updated_at:timestamp",
    "spectrum_measurements": "id:string timestamp:timestamp center_frequency:double sample_rate:double fft_size:int psd_data:string peak_frequencies:string peak_powers:string noise_floor:double snr:double occupied_bandwidth:double detection_id:string",
    "interference_measurements": "id:string timestamp:timestamp frequency:double bandwidth:double power:double type:string severity:double duration:double periodic:boolean period:double detection_id:string",
    "modulation_analysis": "id:string timestamp:timestamp detection_id:string modulation_type:string confidence:double symbol_rate:double carrier_offset:double evm:double phase_noise:double constellation_points:string spectral_features:string",
    "recordings": "id:string session_id:string file_path:string file_format:string duration_seconds:double sample_rate:double center_frequency:double num_samples:long file_size_bytes:long compression_ratio:double start_time:timestamp end_time:timestamp trigger_source:string metadata:string created_at:timestamp",
    "recording_sessions": "id:string name:string description:string start_time:timestamp end_time:timestamp total_duration:double total_size_bytes:long num_files:int tags:string created_at:timestamp",
    "recording_events": "id:string recording_id:string event_type:string event_data:string timestamp:timestamp",
    "geofence_zones": "id:string name:string description:string zone_type:string polygon_coordinates:string center_latitude:double center_longitude:double radius_meters:double altitude_min:double altitude_max:double active:boolean created_at:timestamp updated_at:timestamp",
    "geofence_violations": "id:string detection_id:string zone_id:string latitude:double longitude:double altitude:double distance_to_zone:double timestamp:timestamp resolved:boolean resolved_at:timestamp",
    "geolocation_history": "id:string drone_id:string detection_id:string latitude:double longitude:double altitude:double speed:double heading:double timestamp:timestamp source:string",
    "audit_logs": "id:string user_id:string username:string action:string resource_type:string resource_id:string old_value:string new_value:string ip_address:string user_agent:string status:string error_message:string timestamp:timestamp request_id:string",
    "system_events": "id:string event_type:string event_source:string severity:string message:string details:string timestamp:timestamp acknowledged:boolean resolved:boolean",
    "user_activity": "id:string user_id:string session_id:string activity_type:string activity_data:string duration_seconds:double timestamp:timestamp ip_address:string",
    "configuration_history": "id:string config_key:string config_value:string old_value:string changed_by:string change_reason:string timestamp:timestamp version:int",
    "ml_training_samples": "id:string sample_type:string label:string drone_type:string file_path:string features:string metadata:string source_recording_id:string validated:boolean validation_confidence:double created_at:timestamp",
    "ml_models": "id:string model_name:string model_version:string model_type:string file_path:string accuracy:double precision:double recall:double f1_score:double training_samples:int validation_samples:int hyperparameters:string feature_importance:string is_active:boolean created_at:timestamp trained_at:timestamp training_duration_seconds:double",
    "ml_predictions": "id:string detection_id:string model_id:string predicted_type:string confidence:double alternative_predictions:string features_used:string inference_time_ms:double timestamp:timestamp",
    "ml_training_jobs": "id:string job_name:string status:string config:string result_model_id:string error_message:string started_at:timestamp completed_at:timestamp created_at:timestamp",
}


def struct(table: str) -> T.StructType:
    """Schema of a declared table."""
    return T.StructType.fromDDL(", ".join("`{}` {}".format(*c.split(":")) for c in DECLARED[table].split()))


# The given tables, so streams and scans can declare them too.
GIVEN = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
