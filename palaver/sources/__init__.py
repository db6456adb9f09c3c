"""Reading transcripts: caption files to cues, cues to lines."""
