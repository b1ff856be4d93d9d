"""Reading and writing the operations tables, field feeds and outgoing documents."""
