"""Jobs made of several operators: sync runs, guarded SQL, write-back plans, flows."""
