from .channels import assign_channels, parse_channels, read_channels, valid_channels
from .messages import read_messages, stream_messages
from .policies import parse_policies, policy_id, read_policies
from .sink import read_dispatch, stream_deliveries, write_deliveries, write_dispatch
from .textlogs import parse_frames, parse_metrics_text, read_frames, read_metrics_text

__all__ = [
    "assign_channels", "parse_channels", "parse_frames", "parse_metrics_text", "parse_policies",
    "policy_id", "read_channels", "read_dispatch", "read_frames", "read_messages", "read_metrics_text", "read_policies",
    "stream_deliveries", "stream_messages", "valid_channels", "write_deliveries", "write_dispatch",
]
