"""palaver: transcript, chat and event-log analytics as lazy Spark DataFrame operators."""
