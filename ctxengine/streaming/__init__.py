"""The same operators over streams of turns and events."""
