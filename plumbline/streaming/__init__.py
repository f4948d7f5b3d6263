from plumbline.streaming.incremental import validate_stream

__all__ = ["validate_stream"]
