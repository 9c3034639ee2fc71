from .payments import payments_stream, stream_requests

__all__ = ["payments_stream", "stream_requests"]
